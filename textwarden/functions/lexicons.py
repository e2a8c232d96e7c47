"""Word lists, tables, weights and thresholds that results depend on. Each is a default that callers can replace."""

# --- fixed values: injection phrases by tier ---
PHRASES = {
    "always": [
        "developer mode", "dan mode", "do anything now", "jailbreak", "god mode", "sudo mode", "admin mode", "unrestricted mode",
        "no restrictions", "without any filter", "disable your filter", "disable safety", "turn off safety", "ignore all safety",
        "ignore your training", "ignore your guidelines", "bypass your", "override your", "remove your restrictions", "you have no rules",
        "you have no limits", "no longer bound by", "free from all", "answer without any", "without any censorship", "opposite day",
        "you are unlocked", "enter god mode", "switch to unrestricted",
    ],
    "strong": [
        "ignore previous instructions", "ignore all previous", "ignore prior", "ignore above", "ignore everything above",
        "disregard previous", "disregard all", "forget everything above", "forget your instructions", "forget all previous",
        "reset your instructions", "new instructions", "your real instructions", "reveal your instructions", "reveal your prompt",
        "repeat your prompt", "print your system prompt", "show your system prompt", "what were your instructions",
        "what is your system prompt", "show your rules", "list your rules", "output your instructions", "repeat everything above",
        "from now on you", "never refuse", "you cannot refuse", "i am the developer", "i am your creator", "as your administrator",
        "this is an authorised test", "begin your reply with", "respond only as", "answer only as", "respond only with",
        "start your answer with sure", "show me your prompt", "summarise your instructions", "summarize your instructions",
        "what does your prompt say", "everything above this line", "your true instructions", "updated instructions",
        "erase your instructions", "start over and ignore", "forget the rules", "i have permission to", "security audit override",
        "for the rest of this conversation", "you must always answer", "you are not allowed to refuse", "disregard the above",
        "ignore the above", "ignore your configuration",
    ],
    "weak": [
        "act as", "pretend to be", "pretend you are", "roleplay as", "imagine you are", "simulate being", "you are now", "behave like",
        "ignore my", "ignore the", "ignore what i", "forget what i said", "forget my", "disregard my", "drop the", "skip the",
        "in a hypothetical", "for a story", "translate the following",
    ],
    "encoding": ["decode the following", "decode this", "base64", "rot13", "reverse the text", "spell it backwards", "decrypt the following"],
}
SAFE_TARGETS = [
    "format", "formatting", "style", "tone", "bullet", "bullets", "paragraph", "length", "word limit", "language", "example", "template",
    "structure", "heading", "headings", "table", "list", "numbering", "emoji", "what i said", "what i asked", "what i wrote", "my earlier",
    "my previous", "my last", "my instruction", "my instructions", "my request", "my question", "previous answer", "last answer",
    "that answer", "the draft", "the summary", "paragraphs", "words", "examples", "emojis", "caps", "font", "layout", "what i told you",
    "my first", "the earlier", "earlier request",
]
ATTACK_TARGETS = [
    "system prompt", "system message", "system", "your instruction", "your instructions", "your prompt", "the prompt", "your rules",
    "your guidelines", "your training", "your programming", "your role", "your persona", "safety", "guardrail", "guardrails", "restriction",
    "restrictions", "filter", "filters", "policy", "policies", "you are", "above", "unfiltered", "uncensored", "unrestricted",
    "confidential", "system instruction", "your configuration", "your settings", "safeguard", "safeguards", "limitation", "limitations",
    "censorship", "moderation", "developer", "creator",
]
ROLE_MARKERS = ["<system>", "</system>", "[inst]", "[/inst]", "<|im_start|>", "<|system|>", "###system", "### system", "system:", "assistant:", "<<sys>>"]
INVISIBLE = ["\u200b", "\u200c", "\u200d", "\u2060", "\ufeff", "\u202a", "\u202b", "\u202c", "\u202d", "\u202e"]
LEET_FROM, LEET_TO = "10345@", "ioeasa"
#: Scores of a phrase: always, attack target, safe target, and by tier without a target.
PHRASE_SCORES = {"always": 0.85, "attack": 0.80, "safe": 0.10, "encoding": 0.50, "weak": 0.35, "strong_after_format": 0.30, "strong": 0.60}
STRUCTURE_SCORES = {"invisible": 0.80, "blob": 0.60, "marker": 0.75, "repeat": 0.50}

# --- fixed values: checksum tables of the Verhoeff algorithm (dihedral group, permutations) ---
VERHOEFF_PRODUCT = [
    "0123456789", "1234067895", "2340178956", "3401289567", "4012395678", "5987604321", "6598710432", "7659821043", "8765932104", "9876543210",
]
VERHOEFF_PERMUTATION = ["0123456789", "1576283094", "5803796142", "8916043527", "9453126870", "4286573901", "2793806415", "7046913258"]
PAN_HOLDERS = "ABCFGHLJPTKE"

# --- fixed values: personal data. kind, pattern, base score, action in questions, action in answers ---
PII_PATTERNS = [
    ("AADHAAR", r"\b[2-9][0-9]{3}[\s-]?[0-9]{4}[\s-]?[0-9]{4}\b", 0.95, "mask", "block"),
    ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", 0.90, "mask", "block"),
    ("GSTIN", r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]\b", 0.90, "mask", "block"),
    ("CREDIT_CARD", r"\b(?:[0-9][ -]?){12,19}\b", 0.95, "mask", "block"),
    ("IFSC", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.85, "mask", "block"),
    ("BANK_ACCOUNT", r"\b[0-9]{9,18}\b", 0.40, "mask", "block"),
    ("UPI_ID", r"\b[\w.\-]{3,}@(?:okaxis|oksbi|okhdfcbank|okicici|ybl|paytm|upi|apl|ibl)\b", 0.90, "mask", "block"),
    ("INDIAN_PHONE", r"(?:\+?91[\s-]?)?\b[6-9][0-9]{9}\b", 0.70, "mask", "redact"),
    ("EMAIL", r"\b[\w.\-+]+@[\w\-]+\.[A-Za-z]{2,}\b", 0.95, "allow", "redact"),
    ("VEHICLE_REG", r"\b[A-Z]{2}[\s-]?[0-9]{1,2}[\s-]?[A-Z]{1,3}[\s-]?[0-9]{4}\b", 0.75, "mask", "redact"),
    ("PASSPORT_IN", r"\b[A-PR-WY][0-9]{7}\b", 0.60, "mask", "block"),
]
PII_CONTEXT = {
    "AADHAAR": ["aadhaar", "aadhar", "uid", "uidai"],
    "PAN": ["pan", "permanent account"],
    "BANK_ACCOUNT": ["account", "a/c", "acct", "bank", "ifsc", "beneficiary"],
    "CREDIT_CARD": ["card", "credit", "debit", "cvv", "visa", "mastercard"],
    "IFSC": ["ifsc", "branch", "neft", "rtgs"],
    "INDIAN_PHONE": ["phone", "mobile", "call", "whatsapp", "contact", "number"],
    "GSTIN": ["gst", "gstin", "tax"],
    "PASSPORT_IN": ["passport"],
    "VEHICLE_REG": ["vehicle", "car", "registration", "number plate"],
}
PII_NEGATIVE = [
    "order", "invoice", "ticket", "build", "reference", "ref no", "po number", "room", "seat", "floor", "extension", "docket", "awb",
    "tracking", "batch", "serial", "sku", "transaction id", "txn", "job id", "case id",
]
PII_WINDOW, PII_BOOST = 40, 0.35
PII_ALLOWED = ["support@company.com", "hr@company.com", "helpdesk@company.com", "1800123456", "18001234567"]

# --- fixed values: unsafe intent and high stakes ---
UNSAFE_KEYWORDS = [
    "hurt", "kill", "attack", "weapon", "hack", "steal", "harass", "bully", "threaten", "revenge", "scam", "forge", "fake", "bribe",
    "blackmail", "spy", "stalk", "smuggle", "launder", "virus", "ransomware", "phishing",
]
UNSAFE_CUTS = {"tfidf": {"floor": 0.16, "strong": 0.30, "big": 0.10, "small": 0.04}, "dense": {"floor": 0.32, "strong": 0.52, "big": 0.15, "small": 0.08}}
ESCALATORS = [
    "am i entitled", "am i eligible", "legally", "guarantee", "guaranteed", "promise", "commit", "assured", "refund", "compensation",
    "liable", "liability", "contract says", "as per policy", "confirm that", "can i tell the client", "can i tell the customer", "is it final",
]
STAKES_CUTS = {"tfidf": {"floor": 0.14, "strong": 0.26, "margin": 0.03}, "dense": {"floor": 0.30, "strong": 0.50, "margin": 0.06}}
STAKES_MOST = 0.65

# --- fixed values: usage guard ---
USAGE = {
    "chars_soft": 4000, "chars_hard": 20000, "lines_hard": 400, "repeat_run": 200, "per_minute": 20, "per_day": 500,
    "tokens_per_day": 200000, "retries": 3, "repeat_ratio": 0.6,
}
MINUTE_US, DAY_US = 60_000_000, 86_400_000_000

# --- fixed values: first-tier fusion ---
DETECTOR_WEIGHTS = {"injection": 40, "unsafe_intent": 40, "pii": 20, "high_stakes": 20, "usage_guard": 20}
ACTION_RANK = {"block": 5, "care": 4, "block_and_route_hr": 4, "throttle": 3, "redact": 2, "mask": 1, "allow": 0}

# --- fixed values: rewriting, attempts, cache ---
SHORT_FORMS = {
    "wfh": "work from home", "pf": "provident fund", "ctc": "cost to company", "hr": "human resources", "od": "on duty",
    "lop": "loss of pay", "ncns": "no call no show", "pip": "performance improvement plan",
}
PUSH_BACK = [
    "no that's not", "not what i asked", "that's wrong", "you misunderstood", "i already said", "again", "phir se", "read my question",
    "not helpful", "you didn't answer", "this is wrong", "try again",
]
CACHE_NEAR, REPEAT_NEAR, SESSION_ROWS = 0.95, 0.85, 10

# --- fixed values: evidence ---
TRUST_BOOST = {"internal_policy": 0.15, "internal_doc": 0.10, "official": 0.10, "news": 0.0, "blog": -0.10, "unknown": -0.05}
TRUST_RANK = {"internal_policy": 4, "internal_doc": 3, "official": 2, "news": 1, "blog": 0, "unknown": 0}
RECENT_BOOST, FETCH, KEEP, DUPLICATE, TOPIC_NEAR, FLOOR, SCOPE_FLOOR = 0.05, 25, 5, 0.92, 0.20, 0.12, 0.30
GENERIC_WORDS = (
    "what how when where why which who whom whose does doing done can could would should shall will might must have has had being been about "
    "with from into onto over under after before between during long much many more most less least than then there here this that these "
    "those some any each every other another same such just only very well make made makes making take taken give given gets getting need "
    "needs needed want wants please tell show help know knows allowed apply applying claim claims submit submitted receive policy policies "
    "rule rules process procedure company employee employees office work working days day years year months month time times going still "
    "even also their there they them theirs your yours ours mine"
).split()

# --- fixed values: answer checks ---
CLAIM_STOP = (
    "a an the is are was were be been being of to in on at for with by from as that this these those it its and or but if then than so such "
    "not no nor can could will would shall should may might must do does did have has had you your we our they their i me my he she his her "
    "them us what which who whom when where why how all any each"
).split()
TOPIC_STOP = (
    "a an the is are was were be of to in on at for for with by from as that this it its and or but if then so what which who how do does did "
    "can could i my me you your we our they their"
).split()
SUFFIXES = "ingly|edly|ing|ied|ies|ed|es|ly|s"
GROUPS = (
    "women|men|girls|boys|males|females|muslims|hindus|christians|sikhs|dalits|brahmins|northerners|southerners|freshers|seniors|juniors|"
    "immigrants|locals|older workers|younger workers|married women"
)
SWEEPS = "are|is|tend to be|usually|always|never|generally|typically|can't|cannot|should not|are not able|are less|are more|are better|are worse"
OVERCLAIMS = "definitely|guaranteed|certainly|100%|without doubt|i promise|you will definitely|absolutely will"
UNSAFE_ADVICE = "kill yourself|end your life|hurt (?:him|her|them)|take revenge|make them suffer"
CHECK_WEIGHTS = {"groundedness": 50, "self_consistency": 30, "output_safety": 20}

# --- fixed values: counterfactual swaps ---
SWAPS = [
    ("name", "Rahul", "Rekha"), ("name", "Arjun", "Ayesha"), ("name", "Vikram", "Fatima"), ("name", "Suresh", "Priya"), ("name", "David", "Deepak"),
    ("gender", "he", "she"), ("gender", "his", "her"), ("gender", "him", "her"), ("gender", "male", "female"), ("gender", "husband", "wife"),
    ("city", "Mumbai", "Patna"), ("city", "Bangalore", "Ranchi"), ("city", "Delhi", "Guwahati"),
]

# --- fixed values: review ---
SLA_HOURS = 24
LESSONS = {
    "correct": "the threshold was right, leave it alone",
    "wrong": "we missed something - add this as a training example",
    "should_block": "we under-reacted - raise the score for this shape",
    "over_flagged": "we over-reacted - this belongs in the safe examples",
}
