"""Fixed values.

Everything in this module is a value that has to be exactly this for results to be right:
vocabularies, word lists, weights, patterns, network ranges and message texts. No logic.
"""

# --- vocabularies -------------------------------------------------------------------
BANDS = ("benign", "suspicious", "likely_malicious", "high", "critical")
CLASSIFICATIONS = (
    "benign", "phishing", "spear_phishing", "bec", "credential_phishing", "impersonation",
    "malware_delivery", "extortion", "unknown",
)
CASE_STATUSES = ("received", "analysing", "enriching", "complete", "failed")
ARTIFACT_SOURCES = ("upload", "extension", "api")
PARSE_STATUSES = ("pending", "parsed", "malformed", "rejected")
IP_CLASSES = ("public", "private", "loopback", "link_local", "cgnat", "reserved", "unknown")
HOP_ROLES = ("org_internal", "trusted_provider", "known_forwarder", "external")
TRUST_STATES = ("vouched", "boundary", "asserted", "forged")
AUTH_MECHANISMS = ("spf", "dkim", "dmarc", "arc")
AUTH_RESULTS = (
    "pass", "fail", "softfail", "neutral", "none", "temperror", "permerror", "indeterminate",
)
INDICATOR_TYPES = (
    "ip", "net_prefix", "domain", "host", "url", "email", "file_hash", "asn", "message_id",
)
FINDING_GROUPS = (
    "authentication", "identity", "infrastructure", "url_domain", "content", "attachment",
    "threat_intel", "campaign",
)
SEVERITIES = ("info", "low", "medium", "high", "critical")
EVIDENCE_ACTIONS = (
    "acquired", "parsed", "auth_evaluated", "origin_reconstructed", "enriched", "ai_analysed",
    "scored", "campaign_linked", "analyst_note", "case_viewed", "artifact_downloaded",
    "report_generated", "evidence_verified",
)
JOB_STATES = ("queued", "running", "done", "failed", "dead")
MEMBERSHIP_ROLES = ("owner", "analyst", "viewer")

# --- limits -------------------------------------------------------------------------
CLOCK_SKEW_SECONDS = 300
NARRATIVE_MIN_SCORE = 40

# --- scoring ------------------------------------------------------------------------
WEIGHTS_VERSION = "v1"
GROUP_WEIGHTS = {
    "authentication": 18,
    "identity": 16,
    "url_domain": 15,
    "infrastructure": 12,
    "content": 12,
    "threat_intel": 10,
    "attachment": 9,
    "campaign": 8,
}
BAND_RANGES = {
    "benign": (0, 19),
    "suspicious": (20, 39),
    "likely_malicious": (40, 64),
    "high": (65, 84),
    "critical": (85, 100),
}
DETERMINISTIC_GROUPS = (
    "authentication", "identity", "url_domain", "infrastructure", "attachment", "threat_intel",
)
OFFLINE_GROUPS = (
    "authentication", "identity", "infrastructure", "url_domain", "content", "attachment",
)
CORROBORATION_GROUPS = 2
CORROBORATION_THRESHOLD = 0.70
CORROBORATION_DETERMINISTIC = 1
CAP_WITHOUT_CORROBORATION = 84
AI_CEILING = 65
LEGITIMACY_DAMPENER = -12
SEVERITY_WEIGHTS = {"info": 0.0, "low": 0.25, "medium": 0.55, "high": 0.80, "critical": 1.0}
LEVEL_SCORES = {"none": 0.0, "low": 0.25, "medium": 0.55, "high": 0.80, "extreme": 1.0}

# --- parser patterns ----------------------------------------------------------------
URL_PATTERN = r"""\b((?:https?|ftp)://[^\s<>"'\])}]+|hxxps?://[^\s<>"'\])}]+)"""
HREF_PATTERN = r"""href\s*=\s*["']([^"']+)["']"""
TAG_PATTERN = r"<[^>]+>"
BLANK_PATTERN = "[ \\t\u00a0]+"
URL_TRAILERS = ".,;)>\"'"
ARCHIVE_TYPES = (
    "application/zip", "application/x-zip-compressed", "application/x-rar-compressed",
    "application/x-7z-compressed", "application/gzip", "application/x-tar",
)
ARCHIVE_EXTENSIONS = (".zip", ".rar", ".7z", ".gz", ".tar", ".iso", ".img")
EXTENSION_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".html": "text/html",
    ".htm": "text/html",
}
RAW_HEADER_PROBE = (
    r"(?im)^(Received|Return-Path|From|Delivered-To|MIME-Version|Message-ID):"
)

# --- Received header patterns -------------------------------------------------------
CLAUSE_PATTERN = r"[\[(]([^\])]{2,})[\])]"
ADDRESS_TOKEN_PATTERN = r"(?i)(?:IPv6:)?([0-9a-f:.]{3,45})"
HELO_PATTERN = r"(?is)\bfrom\s+([^\s(;]+)"
RDNS_PATTERN = r"(?is)\bfrom\s+[^\s(;]+\s*\(\s*([A-Za-z0-9._-]+)?\s*[\[(]"
BY_PATTERN = r"(?is)\bby\s+([^\s(;]+)"
WITH_PATTERN = r"(?is)\bwith\s+([A-Za-z0-9/_.-]+)"
ID_PATTERN = r"(?is)\bid\s+([^\s;]+)"
TLS_PATTERN = r"(?is)\((version=TLS[^)]*)\)"

# --- Authentication-Results patterns ------------------------------------------------
AUTHSERV_PATTERN = r"^\s*([A-Za-z0-9._-]+)\s*(?:;|$)"
MECHANISM_PATTERN = r"(?i)\b(spf|dkim|dmarc|arc)\s*=\s*([a-z]+)"
HEADER_D_PATTERN = r"(?i)header\.d\s*=\s*([A-Za-z0-9._-]+)"
HEADER_S_PATTERN = r"(?i)header\.s\s*=\s*([A-Za-z0-9._-]+)"
HEADER_FROM_PATTERN = r"(?i)header\.from\s*=\s*([A-Za-z0-9._-]+)"
MAILFROM_PATTERN = r"(?i)smtp\.mailfrom\s*=\s*([A-Za-z0-9._@-]+)"
SPF_ALL_PATTERN = r"([-~?+])?all\b"

# --- networks -----------------------------------------------------------------------
TRUSTED_PROVIDERS = {
    "microsoft": ("outlook.com", "protection.outlook.com", "office365.com", "microsoft.com"),
    "google": ("google.com", "googlemail.com", "gmail.com", "mx.google.com"),
    "proofpoint": ("pphosted.com", "proofpoint.com"),
    "mimecast": ("mimecast.com",),
    "barracuda": ("barracudanetworks.com", "ess.barracuda.com"),
    "amazon_ses": ("amazonses.com", "amazonaws.com"),
}
SHARED_ESP_MARKERS = (
    "sendgrid.net", "mailgun.org", "mandrillapp.com", "amazonses.com", "sparkpostmail.com",
    "mailchimp.com", "constantcontact.com",
)
FREEMAIL_DOMAINS = (
    "gmail.com", "outlook.com", "hotmail.com", "yahoo.com", "proton.me", "protonmail.com",
)
HUB_VALUES = (
    "gmail.com", "outlook.com", "hotmail.com", "yahoo.com", "google.com", "microsoft.com",
    "bit.ly", "t.co",
)
# IPv4 ranges by class, in order of precedence (RFC 5737 documentation ranges stand in for
# public addresses; the rest follows the IANA special-purpose registry).
IPV4_CLASSES = (
    ("loopback", ("127.0.0.0/8",)),
    ("link_local", ("169.254.0.0/16",)),
    ("public", ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24")),
    ("cgnat", ("100.64.0.0/10",)),
    ("public", ("192.0.0.9/32", "192.0.0.10/32")),
    ("private", (
        "0.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16",
        "198.18.0.0/15", "240.0.0.0/4",
    )),
    ("reserved", ("224.0.0.0/4",)),
)
IPV6_CLASSES = (
    ("loopback", ("::1/128",)),
    ("link_local", ("fe80::/10",)),
    ("public", ("2001:db8::/32",)),
    ("public", (
        "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28",
        "2001:30::/28",
    )),
    ("private", (
        "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2002::/16",
        "3fff::/20", "fc00::/7",
    )),
    ("reserved", (
        "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3",
        "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9",
        "ff00::/8",
    )),
)
DOCUMENTATION_PREFIXES = (
    "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "2001:db8::/32",
)

# --- lexicon ------------------------------------------------------------------------
URGENCY_TERMS = (
    "immediately", "urgent", "asap", "right away", "before close", "today", "time-critical",
    "time critical", "deadline", "expires",
)
AUTHORITY_TERMS = (
    "i am in", "board meeting", "do not call", "don't call", "as ceo", "on my authority",
    "i need you to",
)
SECRECY_TERMS = (
    "do not discuss", "confidential", "keep this between", "don't tell", "do not tell",
    "without informing", "discreet",
)
FINANCIAL_TERMS = (
    "wire", "transfer", "payment", "invoice", "beneficiary", "bank details", "remittance",
    "escrow", "account number",
)
CREDENTIAL_TERMS = (
    "verify your account", "sign in", "log in", "login", "password", "portal",
    "re-authenticate", "confirm your identity",
)
CONTENT_LEXICON = (
    ("CONTENT_URGENCY", "Urgency pressure", "medium", URGENCY_TERMS),
    ("CONTENT_AUTHORITY", "Authority pressure", "medium", AUTHORITY_TERMS),
    ("CONTENT_SECRECY", "Request for secrecy", "high", SECRECY_TERMS),
    ("CONTENT_FINANCIAL", "Financial instruction", "medium", FINANCIAL_TERMS),
    ("CONTENT_CREDENTIAL", "Credential solicitation", "medium", CREDENTIAL_TERMS),
)
CREDENTIAL_URL_MARKERS = (
    "login", "signin", "sign-in", "verify", "auth", "portal", "account", "password", "sso",
)
INVISIBLE_PATTERN = "[\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]"
CONFUSABLES = {
    "\u0430": "a", "\u0435": "e", "\u043e": "o", "\u0440": "p", "\u0441": "c", "\u0445": "x",
    "\u0443": "y", "\u0456": "i", "\u0455": "s", "\u0501": "d", "\u0261": "g", "\u217c": "l",
    "\uff4d": "m", "\u03b1": "a", "\u03bf": "o", "\u03c1": "p", "\u03bd": "v", "\u03c4": "t",
    "0": "o", "1": "l", "5": "s",
}

# --- fingerprint --------------------------------------------------------------------
FINGERPRINT_VERSION = "v1"
LOCUS_WEIGHTS = {"i": 0.22, "d": 0.12, "n": 0.13, "m": 0.28, "c": 0.12, "p": 0.13}
TOOLING_WEIGHTS = {"order": 0.45, "mailer": 0.20, "msgid": 0.20, "boundary": 0.15}
FINGERPRINT_HEADERS = (
    "from", "to", "cc", "bcc", "reply-to", "return-path", "subject", "date", "message-id",
    "mime-version", "content-type", "content-transfer-encoding", "x-mailer", "user-agent",
    "x-priority", "importance", "list-id", "list-unsubscribe", "in-reply-to", "references",
    "organization",
)
PLACEHOLDER_PATTERNS = (
    (r"\b[\d,]+(?:\.\d+)?\b", "<NUM>"),
    (r"https?://\S+", "<URL>"),
    (r"\b[\w.+-]+@[\w.-]+\b", "<EMAIL>"),
    (r"\b\d{1,2}[:.]\d{2}\b", "<TIME>"),
)
CONTENT_TOKEN_PATTERN = r"[a-z<>]{3,}"
MESSAGE_ID_HEX_PATTERN = r"(?i)\b[0-9a-f]{6,}\b"
LINK_THRESHOLD = 0.50
MIN_AGREEING_LOCI = 2
LOCUS_AGREEMENT = 0.50
NON_CONTENT_THRESHOLD = 0.60
NON_CONTENT_LOCI = ("i", "m", "p")
HUB_IDF_THRESHOLD = 1.0
LOCUS_NAMES = {
    "i": "infrastructure", "d": "identity", "n": "naming", "m": "tooling", "c": "content",
    "p": "payload",
}
LOCUS_REASONS = {
    "i": "shared sending infrastructure",
    "d": "shared sender identity",
    "n": "similar domain construction",
    "m": "identical sending toolchain (header order and MIME structure)",
    "c": "similar message template",
    "p": "shared payload or link structure",
}

# --- model guard patterns -----------------------------------------------------------
FACT_PATTERNS = (
    r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    r"(?i)\b[a-z0-9][a-z0-9-]{1,62}(?:\.[a-z]{2,24}){1,3}\b",
    r"(?i)\b[0-9a-f]{32,64}\b",
)
REDACTION_TEXT = "[redacted: not an established indicator]"
FORBIDDEN_PHRASES = (
    "the attacker is located", "the attacker is in", "attacker is based", "travelled through",
    "traveled through", "physically located",
)
FORBIDDEN_NOTICE = (
    " [A statement asserting the operator's physical location was removed: "
    "the evidence does not support such a claim.]"
)

# --- texts shown to readers ---------------------------------------------------------
CLAIM_NO_HEADERS = (
    "No Received headers are present, so no sending infrastructure can be "
    "identified. This is not evidence of legitimacy or of forgery."
)
CLAIM_REFUSED = (
    "No trustworthy receiving infrastructure was identified in the Received "
    "chain, so no sending infrastructure can be attributed. Refusing to "
    "answer is deliberate: a confident answer from insufficient data is the "
    "failure mode this system is built to avoid."
)
CLAIM_TEMPLATE = (
    "Probable originating infrastructure: %s (confidence %d%%). This is the earliest "
    "externally observed sending infrastructure %s. It does NOT establish the physical "
    "location of the operator: the host may be rented, compromised, a proxy, or a legitimate "
    "mailbox whose owner is also a victim."
)
CLAIM_FORWARDED = " Forwarding was detected, which legitimately breaks authentication."
SPF_CAVEAT = (
    "Reported by the receiving MTA at delivery time. SPF is evaluated against DNS as it then "
    "existed; a present-day re-check is corroborating context, not the result."
)
NOTE_LOCAL = "private or loopback address; carries no attribution value"
NOTE_UNCOVERED = "No geolocation dataset covers this address. No country is claimed."
NOTE_NO_ADDRESS = "no address supplied"
NOTE_INVALID = "not a valid IP address"
NOTE_TABLE = (
    "Hand-curated fallback table, not a geolocation database. "
    "Install GeoLite2 for authoritative data."
)
PLAIN_LABELS = {
    "bec": "someone impersonating a colleague to request a payment",
    "credential_phishing": "a fake sign-in page trying to steal your password",
    "spear_phishing": "a targeted scam written specifically for you",
    "phishing": "a scam email",
    "impersonation": "someone pretending to be a person you know",
    "malware_delivery": "an attachment that may be harmful",
    "extortion": "a threat or blackmail attempt",
    "unknown": "something suspicious",
}
PLAIN_BANDS = {
    "benign": "Looks safe",
    "suspicious": "Be careful",
    "likely_malicious": "Probably an attack",
    "high": "Almost certainly an attack",
    "critical": "Dangerous",
}
HEADLINE_BENIGN = "No threat indicators found in this message."
ADVICE_BENIGN = "Nothing to do."
ADVICE_STRONG = (
    "Do not reply, click anything, or pay anything. If it claims to be someone you know, phone "
    "them on a number you already have \u2014 not one from this email."
)
ADVICE_WEAK = "Do not click any link in this email until someone has checked it."
NARRATIVE_BENIGN = (
    "No threat indicators of significance were identified. The message was evaluated across the "
    "available signal groups and scored %s of 100."
)
NARRATIVE_THREAT = (
    "This message was classified as %s with a score of %s of 100 (%s). The determining findings "
    "were: %s. Origin was reconstructed to the earliest externally observed sending "
    "infrastructure with %s%% confidence; this identifies infrastructure, not a person."
)
NARRATIVE_BENIGN_ACTIONS = ("No action required.",)
NARRATIVE_THREAT_ACTIONS = (
    "Do not action any request in this message until verified out of band.",
    "Verify with the apparent sender using a contact from an internal directory, never one "
    "supplied in the message.",
    "Block the identified indicators at the mail gateway and the proxy.",
)

# rule_id -> one plain sentence for readers
RULE_PLAIN_TEXT = {
    "AUTH_INJECTED_RESULTS": (
        "The sender forged a security-check result inside the email, hoping an automated tool "
        "would read it and wave the message through."
    ),
    "AUTH_NO_TRUSTED_RESULTS": (
        "No mail server we recognise vouched for this message, so we cannot confirm who sent "
        "it. That is missing information, not proof of anything."
    ),
    "AUTH_SPF_PASS_UNALIGNED": (
        "The sender proved they own THEIR domain \u2014 not the one they appear to be writing "
        "from. These checks ask whether a domain's paperwork matches itself, never whether the "
        "sender is who they claim to be."
    ),
    "AUTH_DKIM_PASS_UNALIGNED": (
        "The signature on this email belongs to a different domain than the one shown in the "
        "From line."
    ),
    "AUTH_DMARC_PASS_UNALIGNED": (
        "The security checks passed for a domain the sender controls, which is not the domain "
        "they appear to be writing from."
    ),
    "AUTH_SPF_FAIL": (
        "The server that sent this email is not authorised to send for the domain it claims."
    ),
    "AUTH_DKIM_FAIL": (
        "The email's signature does not match, so the message was altered after signing or was "
        "never properly signed."
    ),
    "AUTH_DMARC_FAIL": "This email failed the domain owner's own anti-impersonation policy.",
    "AUTH_ARC_FAIL": "The forwarding chain on this email could not be verified.",
    "AUTH_DMARC_ALIGNED_ESTABLISHED": (
        "The sender's identity checks out for the domain shown. This lowers the score unless "
        "someone is also impersonating a known person."
    ),
    "IDENT_DUPLICATE_FROM": (
        "The email has two different 'From' lines. Your mail app shows one and a filter may "
        "read the other -- a deliberate trick."
    ),
    "IDENT_INVISIBLE_CHARS": (
        "The sender's name contains hidden characters that make it display as something other "
        "than what it is. There is no honest reason to do this."
    ),
    "IDENT_PROTECTED_DISPLAY_NAME": (
        "The sender's display name matches a senior person at your organisation. Most mail "
        "apps show only this name, not the address behind it."
    ),
    "IDENT_LOOKALIKE_DOMAIN": (
        "The sender's domain is a near-copy of one of yours \u2014 close enough to misread at a "
        "glance. The attacker owns it, so it passes every check."
    ),
    "IDENT_REPLY_TO_DIVERGENT": (
        "If you hit Reply, your answer goes somewhere other than where this email appears to "
        "come from."
    ),
    "IDENT_REPLY_TO_FREEMAIL": (
        "Replies to this business email would go to a personal webmail account -- a core sign "
        "of payment fraud."
    ),
    "IDENT_RETURN_PATH_DIVERGENT": (
        "The address that would receive bounces differs from the visible sender."
    ),
    "INFRA_FORGED_RECEIVED": (
        "The delivery stamps on this email contradict each other -- the times run backwards. "
        "Someone wrote them by hand."
    ),
    "INFRA_HANDOFF_BREAK": (
        "The delivery trail has a gap: one server does not match the one before it."
    ),
    "INFRA_NO_TRUST_BOUNDARY": (
        "We could not recognise any of the mail servers in the delivery trail, so we will not "
        "guess where this came from."
    ),
    "INFRA_ASSERTED_HOPS": (
        "Part of the delivery trail was written by the sender themselves. We keep it on record "
        "but do not treat it as evidence."
    ),
    "URL_CREDENTIAL_LANDING": (
        "A link in this email leads to a page asking for a password or sign-in."
    ),
    "URL_LOOKALIKE_HOST": "A link points at a web address built to look like one of yours.",
    "ATTACH_TYPE_MISMATCH": (
        "An attachment's file extension does not match what the file actually is."
    ),
    "ATTACH_ARCHIVE": (
        "The email carries a zip or archive. We record its fingerprint but never open it."
    ),
    "ATTACH_PRESENT": (
        "The email has an attachment. We recorded its fingerprint without opening it."
    ),
    "CONTENT_URGENCY": (
        "The message pushes for immediate action, which is how fraud gets past someone's "
        "judgement."
    ),
    "CONTENT_AUTHORITY": (
        "The message leans on seniority and discourages you from checking."
    ),
    "CONTENT_SECRECY": (
        "The message asks you to keep it quiet \u2014 a strong sign of fraud, because secrecy "
        "exists to stop you verifying."
    ),
    "CONTENT_FINANCIAL": (
        "The message asks for money to move, or for bank details to change."
    ),
    "CONTENT_CREDENTIAL": "The message asks you to sign in or confirm a password.",
}

# rule_id -> (group, severity, title, MITRE technique); %s is filled per message
RULES = {
    "AUTH_INJECTED_RESULTS": (
        "authentication", "critical",
        "Forged Authentication-Results header injected by the sender", "T1656",
    ),
    "AUTH_NO_TRUSTED_RESULTS": (
        "authentication", "medium",
        "No Authentication-Results from recognised infrastructure", None,
    ),
    "AUTH_%s_PASS_UNALIGNED": (
        "authentication", "high", "%s passed, but not for the identity shown to the recipient",
        None,
    ),
    "AUTH_%s_FAIL": ("authentication", "high", "%s failed", None),
    "AUTH_DMARC_ALIGNED_ESTABLISHED": (
        "authentication", "info", "DMARC passed and is aligned to the sending identity", None,
    ),
    "IDENT_DUPLICATE_FROM": ("identity", "critical", "Multiple From headers", "T1656"),
    "IDENT_INVISIBLE_CHARS": (
        "identity", "high", "Invisible characters in sender display name", "T1656",
    ),
    "IDENT_PROTECTED_DISPLAY_NAME": (
        "identity", "high", "Display name claims a protected identity: %s", "T1656",
    ),
    "IDENT_LOOKALIKE_DOMAIN": (
        "identity", "critical", "Sender domain resembles a protected domain (%s)", "T1656",
    ),
    "IDENT_REPLY_TO_DIVERGENT": (
        "identity", "medium", "Replies leave the sending domain", "T1656",
    ),
    "IDENT_REPLY_TO_FREEMAIL": (
        "identity", "high", "Replies are directed to a free webmail account", None,
    ),
    "IDENT_RETURN_PATH_DIVERGENT": (
        "identity", "medium", "Envelope sender differs from the visible From domain", None,
    ),
    "INFRA_FORGED_RECEIVED": (
        "infrastructure", "high", "Forged Received header: timestamps run backwards", "T1656",
    ),
    "INFRA_HANDOFF_BREAK": (
        "infrastructure", "medium", "Break in Received-chain continuity", None,
    ),
    "INFRA_NO_TRUST_BOUNDARY": (
        "infrastructure", "medium",
        "No recognised receiving infrastructure in the Received chain", None,
    ),
    "INFRA_ASSERTED_HOPS": (
        "infrastructure", "low", "%s Received header(s) below the trust boundary", None,
    ),
    "URL_CREDENTIAL_LANDING": (
        "url_domain", "high", "Link points at a credential-entry page", "T1566.002",
    ),
    "URL_LOOKALIKE_HOST": (
        "url_domain", "high", "Link host imitates a protected domain (%s)", "T1566.002",
    ),
    "ATTACH_TYPE_MISMATCH": (
        "attachment", "high", "Attachment extension disagrees with its declared type: %s",
        "T1566.001",
    ),
    "ATTACH_ARCHIVE": ("attachment", "low", "Archive attachment: %s", None),
    "ATTACH_PRESENT": ("attachment", "low", "Attachment: %s", None),
}
