"""Fixed values of the audit: word lists, lookup tables, weights, cut-offs.

Everything in this module is data that must have exactly these values for the
results to be right.  Order matters: matched phrases are reported in list order.
"""

# ---------------------------------------------------------------- priorities
# Assigned priority (trimmed, lower case) -> level, and back.
PRIORITY_LEVEL = {"low": 1, "medium": 2, "high": 3, "critical": 4}
LEVEL_LABEL = {1: "Low", 2: "Medium", 3: "High", 4: "Critical"}
DEFAULT_LEVEL = 2
MISMATCH_DELTA = 2

# Mismatch types.
CONSISTENT = "Consistent"
HIDDEN_CRISIS = "Hidden Crisis"
FALSE_ALARM = "False Alarm"
MISMATCH_TYPES = (CONSISTENT, HIDDEN_CRISIS, FALSE_ALARM)

# Free mail providers; every other domain counts as enterprise.
FREE_MAIL_DOMAINS = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com")

# ------------------------------------------------------------------- columns
# Accepted source column names, in order of preference per target.
FULL_ALIASES = {
    "ticket_id": ("ticket_id",),
    "ticket_subject": ("ticket_subject", "subject"),
    "ticket_description": ("ticket_description", "description"),
    "ticket_priority": ("ticket_priority", "priority_level", "priority"),
    "ticket_channel": ("ticket_channel", "channel"),
    "ticket_type": ("ticket_type", "issue_category", "category"),
    "resolution_hours": (
        "resolution_time_(in_hours)", "resolution_time_hours", "resolution_time",
    ),
    "customer_email": ("customer_email", "email"),
}
CPU_ALIASES = {
    "ticket_id": ("ticket_id",),
    "ticket_subject": ("ticket_subject",),
    "ticket_description": ("ticket_description",),
    "ticket_priority": ("priority_level", "ticket_priority"),
    "ticket_channel": ("ticket_channel",),
    "ticket_type": ("issue_category", "ticket_type"),
    "resolution_hours": (
        "resolution_time_hours", "resolution_time_(in_hours)", "resolution_hours",
    ),
    "customer_email": ("customer_email",),
}
REQUIRED_COLUMNS = ("ticket_subject", "ticket_description", "ticket_priority")

# What a missing text column or cell becomes.
FILL_DEFAULTS = {
    "ticket_subject": "",
    "ticket_description": "",
    "ticket_type": "Unknown",
    "ticket_channel": "Unknown",
    "customer_email": "user@unknown.com",
}
# Defaults of a live (single ticket) request.
LIVE_DEFAULTS = {
    "ticket_subject": "",
    "ticket_description": "",
    "ticket_priority": "Medium",
    "ticket_channel": "Email",
    "ticket_type": "General",
    "customer_email": "user@unknown.com",
}
# Defaults of a table of labelled robustness cases.
CASE_DEFAULTS = {
    "ticket_subject": "",
    "ticket_description": "",
    "ticket_priority": "Medium",
    "ticket_channel": "Email",
    "ticket_type": "General",
    "customer_email": "u@x.com",
}
# CSV cells that mean "missing".
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# ------------------------------------------------------------ keyword lexicon
# Four-tier lexicon of the full profile.
FULL_CRITICAL = (
    "system down", "complete outage", "total outage", "service outage",
    "production down", "not working", "completely broken", "unavailable",
    "data loss", "data breach", "security breach", "unauthorized access",
    "credentials exposed", "account hacked", "phishing", "ransomware",
    "revenue impact", "losing customers", "sla breach", "sla violation",
    "critical failure", "mission critical", "all users affected",
    "cannot access", "locked out", "cannot login", "unable to login",
    "emergency", "asap", "immediately", "right now", "this moment",
    "escalate to", "executive", "ceo", "cto", "vp",
)
FULL_HIGH = (
    "error", "broken", "fails", "failure", "disruption", "degraded",
    "slow", "performance issue", "intermittent", "recurring issue",
    "multiple users", "several users", "team cannot", "blocking",
    "workaround", "no workaround", "deadline", "impacted",
    "incorrect data", "wrong data", "missing data", "corrupt",
)
FULL_MEDIUM = (
    "issue", "problem", "not working correctly", "unexpected behavior",
    "sometimes", "occasionally", "some users", "one user",
    "help needed", "question", "how to", "need assistance",
)
FULL_LOW = (
    "minor", "cosmetic", "typo", "small issue", "slight",
    "enhancement", "feature request", "suggestion", "nice to have",
    "when convenient", "low priority", "no rush", "feedback",
    "improvement", "would be nice", "wondering if",
)
# Three-tier lexicon of the cpu profile.
CPU_CRITICAL = (
    "system down", "complete outage", "total outage", "production down",
    "not working", "completely broken", "unavailable",
    "data loss", "data breach", "security breach", "unauthorized access",
    "credentials exposed", "account hacked", "ransomware",
    "exported to", "unrecognized ip", "foreign country",
    "entire customer database", "database exported", "exfiltration",
    "revenue impact", "losing customers", "losing approximately",
    "per hour in revenue", "revenue loss", "revenue", "finance team",
    "escalating to the board", "payment processing pipeline",
    "process a single transaction", "k/hour",
    "sla breach", "sla violation", "critical failure", "mission critical",
    "legal deadline", "legal team", "sla breach penalties",
    "all users affected", "cannot access", "locked out", "cannot login",
    "unable to login", "4200 seats",
    "emergency", "asap", "immediately", "right now",
    "escalate to", "executive", "ceo", "cto", "vp",
    "outage", "breach", "payment failed", "payroll",
    "hospital", "icu", "patient", "patient vitals", "life",
    "gdpr", "pii", "eu data",
    "silently failing", "silent failure", "78% of our arr",
    "top 3 enterprise clients", "enterprise clients",
    "returns a 200 status but no data", "200 status but no data",
    "6 days", "six days",
    "2300 employees", "complete payroll", "payroll module", "no transfers",
    "vitals", "icu monitoring", "delayed by 45 seconds",
)
CPU_HIGH = (
    "error", "broken", "fails", "failure", "disruption", "degraded", "slow",
    "intermittent", "recurring", "multiple users", "several users", "blocking",
    "workaround", "no workaround", "deadline", "impacted", "incorrect data",
    "wrong data", "missing data", "corrupt", "crashing", "crashes", "freeze",
    "authenticate", "sso", "single sign", "api", "integration", "syncing",
)
CPU_LOW = (
    "minor", "cosmetic", "typo", "small issue", "slight", "enhancement",
    "feature request", "suggestion", "nice to have", "when convenient",
    "low priority", "no rush", "feedback", "improvement", "wondering if",
    "font", "color", "colour", "button", "icon", "ui",
    "resolves itself", "page refresh", "after a refresh",
    "slightly different numbers", "slightly off", "brand guidelines",
    "font size", "profile page", "no rush at all", "totally not important",
    "when i get a chance", "brand color", "one pixel", "1-pixel",
)
# Phrases of the cpu lists that the live lists leave out.  The web
# form keeps two critical phrases that the service drops.
LIVE_FORM_CRITICAL_OMITS = (
    "database exported", "per hour in revenue", "process a single transaction",
    "legal team", "sla breach penalties", "4200 seats", "life", "eu data",
    "silent failure", "78% of our arr", "top 3 enterprise clients",
    "returns a 200 status but no data", "200 status but no data",
    "complete payroll", "no transfers", "icu monitoring",
)
LIVE_SERVICE_CRITICAL_OMITS = ("account hacked", "patient vitals")
LIVE_HIGH_OMITS = ("single sign",)
LIVE_LOW_OMITS = ("after a refresh", "when i get a chance", "one pixel", "1-pixel")

# Negations, looked for in the five tokens before a phrase.
FULL_NEGATIONS = (
    "not", "no", "never", "without", "resolved", "fixed", "working",
    "works fine", "working now", "already", "don't", "doesn't", "isn't",
    "wasn't", "haven't", "has been resolved", "was resolved",
)
CPU_NEGATIONS = (
    "not", "no", "never", "without", "resolved", "fixed", "working",
    "works fine", "working now", "already", "don't", "doesn't", "isn't",
    "was resolved",
)
NEGATION_WINDOW = 5

# Intensifiers.
FULL_INTENSIFIERS = (
    "very", "extremely", "highly", "absolutely", "completely",
    "totally", "severely", "badly", "terribly", "desperately",
)
CPU_INTENSIFIERS = (
    "very", "extremely", "highly", "absolutely", "completely",
    "severely", "badly", "terribly", "desperately",
)
LIVE_INTENSIFIERS = (
    "very", "extremely", "highly", "absolutely", "completely", "severely",
)

# Channel multipliers (default 1.0).
FULL_CHANNEL_WEIGHT = {
    "phone": 1.15, "chat": 1.05, "email": 1.0, "social media": 1.2,
    "web": 0.95, "portal": 0.95, "unknown": 1.0,
}
CPU_CHANNEL_WEIGHT = {
    "phone": 1.15, "chat": 1.05, "email": 1.0, "social media": 1.2,
    "web": 0.95, "web form": 0.95, "portal": 0.95, "unknown": 1.0,
}

# Points per phrase and per intensifier, raw score cut-offs.
TIER_POINTS = {"critical": 3.0, "high": 1.5, "medium": 0.5, "low": -0.8}
INTENSIFIER_POINTS = 0.5
RAW_CUTOFFS = (0.5, 2.5, 5.0)

# --------------------------------------------------------- zero-shot severity
# Words of the heuristic that stands in for a model.
HEURISTIC_CRITICAL = (
    "outage", "breach", "data loss", "system down", "cannot access",
    "not working", "critical", "urgent", "emergency", "security",
    "revenue", "production down", "all users affected",
)
HEURISTIC_HIGH = (
    "broken", "error", "fails", "disruption", "multiple users",
    "recurring", "escalate", "no workaround",
)
HEURISTIC_LOW = (
    "minor", "cosmetic", "suggestion", "when convenient",
    "low priority", "feedback", "nice to have", "enhancement",
)
# Fixed value: the prompt.  {0}..{3} = subject, description, channel, type.
PROMPT = """You are a support ticket severity analyst. Analyze the following support ticket and output ONLY a valid JSON object with no extra text.

Support Ticket:
Subject: {0}
Description: {1}
Channel: {2}
Type: {3}

Output format (respond ONLY with this JSON, no markdown, no explanation):
{{"severity": <integer 1-4>, "reason": "<one direct quote or close paraphrase from the ticket text>"}}

Severity scale:
1 = Low (minor inconvenience, cosmetic, no business impact)
2 = Medium (moderate impact, workaround available)
3 = High (significant disruption, no workaround, affects multiple users)
4 = Critical (complete outage, data loss, security breach, revenue impact)"""
PROMPT_SUBJECT_CHARS = 300
PROMPT_DESCRIPTION_CHARS = 800

# ------------------------------------------------------------ resolution time
# Default severity cut-offs and classifier text bins, in hours.
DEFAULT_HOUR_CUTOFFS = (24.0, 72.0, 168.0)
TIME_BINS = ("fast", "moderate", "slow", "very_slow")
# Expected hours per assigned level.
BASELINE_HOURS = {1: 12.0, 2: 48.0, 3: 120.0, 4: 4.0}
SLOW_RATIO = 1.5
FAST_RATIO = 0.4

# -------------------------------------------------------------------- fusion
# Signal weights, in summation order.
FULL_FUSION = {
    "severity_llm": 0.40, "severity_resolution": 0.30,
    "severity_rules": 0.20, "severity_cluster": 0.10,
}
CPU_FUSION = {
    "severity_resolution": 0.35, "severity_rules": 0.35, "severity_cluster": 0.30,
}

# ---------------------------------------------------------------- classifier
# Split shares, threshold candidates and the quality gate.
TEST_SHARE = 0.15
VALIDATION_SHARE = 0.15
SWEEP_START, SWEEP_STOP, SWEEP_STEP = 0.30, 0.70, 0.02
DEFAULT_THRESHOLD = 0.5
GATE = {
    "accuracy": 0.83, "macro_f1": 0.82,
    "recall_consistent": 0.78, "recall_mismatch": 0.78,
}

# High-urgency and self-service channels in the dossier.
URGENT_CHANNELS = ("social media", "phone")
SELF_SERVICE_CHANNELS = ("web", "portal")
