"""Screening vocabularies and regular expressions.

The lists under "FIXED VALUES" must equal the screened behaviour we match
(patterns in Python ``re`` syntax, words as lower-case substrings). They are
kept verbatim and in their natural order; ``portable()`` turns a Python
pattern into text that Java regex (Spark) and RE2 (the DuckDB oracle) both
evaluate with Python's Unicode semantics.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference behaviour; do not edit)
# ---------------------------------------------------------------------------

INJECTION_PATTERNS = [
    r"ignore\s+(all\s+)?(previous|prior|above)?\s*(instructions?|prompts?|rules?|guidelines?)",
    r"(reveal|show|display|output|print|repeat)\s+(\w+\s+)*(the\s+)?(system\s+)?(prompt|instructions?|rules?)",
    r"you\s+are\s+now\s+(a|an|my)\s+",
    r"act\s+as\s+(a|an|if)\s+",
    r"forget\s+(everything|all|your)\s+",
    r"override\s+(your|the|all)\s+",
    r"disregard\s+(your|the|all|previous)\s+",
    r"new\s+instructions?\s*:",
    r"system\s*:\s*",
    r"<\s*system\s*>",
    r"jailbreak",
    r"do\s+anything\s+now",
    r"bypass\s+(the\s+)?(filter|guard|safety|restriction)",
    r"pretend\s+(you\s+)?(are|to\s+be)\s+",
]

FINANCIAL_KEYWORDS = [
    "spend", "spent", "spending", "expense", "expenses", "income", "salary",
    "saving", "savings", "budget", "money", "financial", "transaction",
    "category", "merchant", "payment", "cost", "charge", "bill",
    "trend", "month", "monthly", "weekly", "daily", "report", "summary",
    "total", "average", "breakdown", "chart", "graph", "plot", "show",
    "how much", "where", "what", "when", "top", "most", "least",
    "food", "rent", "housing", "travel", "insurance", "gym", "health",
    "transport", "entertainment", "shopping", "groceries", "restaurant",
    "subscription", "streaming", "fuel", "utilities", "internet",
    "refund", "cashback", "freelance",
]

OFF_TOPIC_PATTERNS = [
    r"(write|compose|create)\s+(\w+\s+)*(poem|song|story|essay|code|script)",
    r"(what|who)\s+is\s+the\s+(president|capital|population)",
    r"(translate|convert)\s+.+\s+(to|into)\s+(french|spanish|german|japanese)",
    r"(tell|say)\s+(me\s+)?a\s+joke",
    r"(how|what)\s+(do|does|is|are)\s+.*(weather|news|sports|politics|recipe|cook)",
    r"(play|sing|dance|draw|paint)\s+",
]

USER_ID_PATTERN = r"usr_[a-z0-9]+"

CROSS_USER_PATTERNS = [
    r"(another|other|different)\s+user",
    r"user[_\s]?\w+('s|s)\s+(spending|data|transaction|income|expense)",
    r"(show|tell|give)\s+me\s+.*(someone|somebody)\s*(else)?",
]

MAX_PROMPT_LENGTH = 500

TOXICITY_KEYWORDS = [
    "fuck", "shit", "damn", "bitch", "ass", "bastard", "crap",
    "idiot", "stupid", "moron", "dumb", "retard", "kill", "die",
    "hate", "racist", "sexist",
]

HEDGING_PHRASES = [
    "i'm not sure", "i am not sure", "i think", "might be", "could be",
    "it seems", "not certain", "unclear",
    "hard to say", "difficult to determine", "insufficient data",
    "not enough information", "cannot determine",
]

DOLLAR_PATTERN = r"\$[\d,]+\.?\d*"
PLAIN_NUMBER_PATTERN = r"(?<!\w)(\d{2,}(?:,\d{3})*(?:\.\d+)?)(?!\w)"

MONTH_NUMBERS = {
    "january": 1, "february": 2, "march": 3, "april": 4,
    "may": 5, "june": 6, "july": 7, "august": 8,
    "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4,
    "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}
MONTH_YEAR_PATTERN = (
    r"(january|february|march|april|may|june|july|august|september|october|november|december|"
    r"jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)\s+(\d{4})"
)

GROUNDING_TOLERANCE = 0.05
SPARSE_ROWS = 5
MAX_INPUT_TOKENS = 6000
BREAKER_THRESHOLD = 3
BREAKER_COOLDOWN_SECONDS = 60
HISTORY_KEPT = 5
HISTORY_USED = 3

INJECTION_MESSAGE = (
    "I appreciate your curiosity, but I can only help with questions about "
    "your financial transactions. I'm unable to modify my instructions or "
    "share system details. Please ask me about your spending, income, or "
    "financial trends instead!"
)
OFF_TOPIC_MESSAGE = (
    "I'm your financial transaction assistant and can only help with questions "
    "about your spending, income, savings, and transaction history. "
    "Try asking something like 'What did I spend the most on last month?' or "
    "'Show me my spending trend.'"
)
CROSS_USER_MESSAGE = (
    "For privacy and security, I can only provide information about your own "
    "financial transactions. I'm unable to share details about other users' data."
)
TRUNCATED_MESSAGE = f"Your prompt was truncated to {MAX_PROMPT_LENGTH} characters."
TOXIC_MESSAGE = "The response contained inappropriate content and has been filtered."
HALLUCINATION_MESSAGE = (
    "Note: Some figures or dates in the response could not be verified against your actual data."
)
HEDGING_NOTE = " The analysis expresses some uncertainty."
SPARSE_NOTE = (" Note: This analysis is based on only {n} transaction(s), "
               "which may limit accuracy.")

# flag -> (severity, label); unknown flags map to ("info", flag)
FLAG_SEVERITY = {
    "PROMPT_INJECTION_DETECTED": ("error", "Prompt Injection Blocked"),
    "CROSS_USER_LEAKAGE_ATTEMPT": ("error", "Cross-User Access Blocked"),
    "OFF_TOPIC": ("warning", "Off-Topic Query"),
    "TOXIC_CONTENT_DETECTED": ("error", "Toxic Content Filtered"),
    "POTENTIAL_HALLUCINATION": ("warning", "Possible Hallucination"),
    "UNGROUNDED_NUMBER": ("warning", "Ungrounded Number"),
    "UNGROUNDED_DATE": ("warning", "Ungrounded Date"),
    "LLM_UNAVAILABLE": ("warning", "LLM Unavailable — Used Fallback"),
    "CIRCUIT_BREAKER_OPEN": ("error", "Circuit Breaker Open"),
    "CIRCUIT_BREAKER_TRIPPED": ("error", "Circuit Breaker Tripped"),
    "INPUT_TRUNCATED": ("info", "Input Truncated"),
    "LOW_CONFIDENCE": ("info", "Low Confidence"),
    "SPARSE_DATA": ("info", "Limited Data"),
    "NO_DATA_FOR_QUERY": ("info", "No Matching Data"),
    "MALFORMED_TOOL_CALL_RETRY": ("warning", "Tool Call Retried"),
    "CONTEXT_TRUNCATED": ("info", "Context Truncated"),
    "SYSTEM_ERROR": ("error", "System Error"),
}

# operation descriptions stored in the query history, chosen by keyword group
OPERATION_WITH_CHARTS = "df.groupby('category')['transaction_amount'].sum().plot()"
OPERATION_RULES = [
    (["category", "most", "breakdown", "top"],
     "df.groupby(parent_category)['transaction_amount'].sum().sort_values(ascending=False)"),
    (["trend", "month", "over time", "pattern"],
     "df.resample('ME', on='transaction_date')['transaction_amount'].sum()"),
    (["income", "expense", "saving", "financial", "net"],
     "df.groupby(df['transaction_amount'] > 0)['transaction_amount'].agg(['sum', 'count'])"),
    (["total", "sum", "how much"], "df['transaction_amount'].sum()"),
]
OPERATION_DEFAULT = "df.query(\"user_id == '{user_id}'\").describe()"

PERIOD_MONTHS = {"last_1_month": 1, "last_3_months": 3, "last_6_months": 6, "all": 999}
DEFAULT_PERIOD_MONTHS = 3

# ---------------------------------------------------------------------------
# Portable regex: Python-re semantics in Java regex and RE2
# ---------------------------------------------------------------------------

# characters Python's str.strip() removes (derived by rule, 29 of them)
PY_WHITESPACE = "".join(c for c in map(chr, range(0x110000)) if c.isspace())

# str.isspace() characters
_SPACE_BODY = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
               r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# str.isalnum() or underscore
_WORD_BODY = r"\p{L}\p{N}_"
_DIGIT_BODY = r"0-9"


def _rewrite_nested_words(p: str) -> str:
    """``\\s+(\\w+\\s+)*`` backtracks recursively in Java (stack overflow on
    long texts); ``\\s(?:[\\w\\s]*\\s)?`` accepts the same strings and runs
    as a flat loop."""
    return p.replace(r"\s+(\w+\s+)*", r"\s(?:[\w\s]*\s)?")


def portable(pattern: str, flat: bool = True) -> str:
    """Rewrite shorthand classes so Java and RE2 agree with Python ``re``.
    With ``flat`` nested word loops become flat ones, which only Java needs.

    ``\\s``/``\\w`` become explicit Unicode classes, ``\\d`` ASCII digits
    and ``.`` "anything but newline" (Java's ``.`` also stops at \\r and
    \\u2028, Python's only at \\n).
    """
    p = _rewrite_nested_words(pattern) if flat else pattern
    out = []
    in_class = False
    i = 0
    while i < len(p):
        ch = p[i]
        if ch == "\\" and i + 1 < len(p):
            nxt = p[i + 1]
            body = {"s": _SPACE_BODY, "w": _WORD_BODY, "d": _DIGIT_BODY}.get(nxt)
            if body is not None:
                out.append(body if in_class else f"[{body}]")
            else:
                out.append(p[i:i + 2])
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        elif ch == "." and not in_class:
            out.append(r"[^\n]")
            i += 1
            continue
        out.append(ch)
        i += 1
    return "".join(out)


def any_of(patterns: list[str], flat: bool = True) -> str:
    """One alternation; a search for it hits iff one of the patterns hits."""
    return "|".join(f"(?:{portable(p, flat)})" for p in patterns)


# A plain number may only start where a word starts and must end where a word
# ends. Java runs the look-around form directly; RE2 has no look-around, so
# the oracle scans word by word: each match consumes either a number plus the
# non-word character after it, or a whole word, or one other character.
PLAIN_NUMBER_JAVA = portable(PLAIN_NUMBER_PATTERN)
PLAIN_NUMBER_SCAN = (
    portable(r"(\d{2,}(?:,\d{3})*(?:\.\d+)?)") + "(?:" + f"[^{_WORD_BODY}]" + "|$)"
    + "|" + f"[{_WORD_BODY}]+" + "|" + r"[^\p{L}\p{N}_]"
)
DOLLAR_PORTABLE = portable(DOLLAR_PATTERN)
MONTH_YEAR_PORTABLE = portable(MONTH_YEAR_PATTERN)
