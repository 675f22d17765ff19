"""Patterns, priorities, limits and messages.

Every pattern is written for ``java.util.regex``. ``\\d`` and ``\\s`` are ASCII there,
but ``\\b`` is Unicode-aware before JVM 19, so the e-mail boundaries are spelled out
with ASCII look-arounds and mean the same on every JVM.
"""

# --- fixed values: types and overlap priority (lower wins at an equal start) ---
PRIORITY = {
    "URL": 10,
    "EMAIL": 20,
    "IP_ADDRESS": 30,
    "CREDIT_CARD": 40,
    "SSN": 50,
    "PHONE": 60,
}

# --- fixed values: candidate patterns ---
# A look-ahead for the possible first characters comes first wherever a pattern opens
# with a look-behind: it changes no match and rejects most positions with one test.
# An e-mail starts on an ASCII word boundary: either a word character after a
# non-word one, or one of . % + - right after a word character. It ends in a letter,
# so the closing boundary is "no word character follows". ``\w`` is ASCII here.
EMAIL = (
    r"(?:(?=\w)(?<!\w)|(?=[.%+-])(?<=\w))"
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?!\w)"
)
# The same matches, found in one try per run of local-part characters: all starts within a run
# meet the same ``@``, and the first boundary of a run is its first word character, or the place
# where the match before ended. What stands before that is matched, but not in group 1.
EMAIL_RUN = (
    r"(?:(?<![A-Za-z0-9._%+-])[.%+-]*+(?=\w)|\G(?<=\w)(?=[.%+-]))"
    r"([A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?!\w))"
)
URL = r"""https?://[^\s<>"'()\[\]{}]+"""
IP_ADDRESS = r"(?=\d)(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"
CREDIT_CARD = r"(?=\d)(?<![A-Za-z0-9])(?:\d[\s.-]?){13,19}(?![A-Za-z0-9])"
SSN = r"(?=\d)(?<![A-Za-z0-9])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9])"
PHONE = (
    r"(?=[\d+(])(?<!\d)(?<!\d[\s().-])(?:\+\d{1,3}[\s.-]?)?"
    r"(?:\(\d{2,5}\)[\s.-]?\d[\d\s().-]{4,15}\d|\d[\d\s().-]{5,16}\d)"
    r"(?![\s().-]*\d)"
)

# --- fixed values: what is cut off the end of a match ---
URL_TAIL = ".,;:!?)]}\"'"
CARD_TAIL = " \t\n\x0b\f\r.-"

# --- fixed values: post-validation bounds ---
MAX_OCTET = 255
CARD_DIGITS = (13, 19)
PHONE_DIGITS = (7, 15)
PLAIN_PHONE_DIGITS = 10

# Necessary conditions, each far cheaper than the pattern it stands before.
# Every IP, card, SSN and phone candidate contains a stretch of at least seven
# characters that begins and ends in a digit and holds only these separators.
EMAIL_HINT = "@"
URL_HINT = "://"
SSN_HINT = "-"
DIGITS_HINT = r"\d[\d\s().-]{5,}\d"

# --- fixed values: tokens ---
TOKEN_FORMAT = "{{%s_%03d}}"
TOKEN_TEMPLATE = r"\{\{(?:%s)_\d{3,}\}\}"  # filled with the known type names
TOKEN_NUMBER = r"_(\d+)\}\}$"
TOKEN_HINT = "{{"
DISPLAY_TOKEN = r"\{\{[A-Z_]+_\d+\}\}"

# --- fixed values: limits and defaults ---
MAX_TEXT_LENGTH = 10_000  # UTF-16 units
MAPPING_TTL_SECONDS = 600
BUCKET_CAPACITY = 120
BUCKET_REFILL_PER_MINUTE = 120
MESSAGE_LIMIT = 300

# --- fixed values: providers and their request bodies ---
PROVIDERS = ("mock", "openai", "anthropic")
OPENAI_MODEL = "gpt-4o-mini"
ANTHROPIC_MODEL = "claude-sonnet-4-20250514"
ANTHROPIC_MAX_TOKENS = 4096
MOCK_SUFFIX = " Mock analysis completed."

# --- fixed values: failure kind -> (status, reason, message) ---
ERRORS = {
    "bad_input": (400, "Bad Request", "Invalid request."),
    "too_large": (413, "Payload Too Large",
                  "Request text exceeds the maximum allowed length of %d characters."),
    "unsupported_provider": (400, "Bad Request", "Unsupported provider."),
    "throttled": (429, "Too Many Requests", "Too many requests."),
    "provider_failure": (502, "Bad Gateway", "LLM provider request failed."),
    "provider_timeout": (504, "Gateway Timeout", "LLM provider request timed out."),
    "key_config": (500, "Internal Server Error", "Encryption is not configured correctly."),
    "protection": (500, "Internal Server Error", "Failed to process request securely."),
    "other": (500, "Internal Server Error", "Unexpected error."),
}
FALLBACK_MESSAGE = "Request failed."

# --- fixed values: status -> outcome shown to a caller ---
OUTCOMES = {
    401: "unauthorized",
    429: "rate-limited",
    413: "too-large",
    400: "bad-request",
    502: "provider-error",
    504: "provider-error",
}
