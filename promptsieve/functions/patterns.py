"""Detection patterns, and their rendering for the two regex engines in use.

The patterns are written as the ECMAScript sources whose results must be
reproduced.  Java (Spark) and RE2 (the SQL oracle) disagree with ECMAScript on a
few escapes, so each pattern is rendered per engine by the rules in `_render`:

* ``\\b`` is ASCII in ECMAScript and RE2 but Unicode-aware on JDK 17, so Java gets
  ASCII look-arounds;
* ``\\s``, ``\\S`` and ``.`` cover different characters in all three;
* ``/i`` folds ASCII letters only, which is Java's ``(?i)`` without ``(?u)``.
"""

from __future__ import annotations

from dataclasses import dataclass

# ECMAScript white space, as the inside of a character class.
_SPACE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_NOT_NEWLINE = r"[^\n\r\x{2028}\x{2029}]"
_WORD_START = r"(?<!\w)"
_WORD_END = r"(?!\w)"
_WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


@dataclass(frozen=True)
class Pattern:
    name: str
    source: str
    ignore_case: bool = False
    weight: float = 0.0
    # True where the text beside a \b may be a non-word character, so that the
    # cheap one-sided look-around would not be equivalent.
    open_edges: bool = False
    # Equivalent Java form where the plain one backtracks quadratically.
    java_source: str | None = None

    @property
    def java(self) -> str:
        return _render(self, java=True)

    @property
    def re2(self) -> str:
        return _render(self, java=False)


def _render(pattern: Pattern, java: bool) -> str:
    source = pattern.java_source if java and pattern.java_source else pattern.source
    out, in_class, i = [], False, 0
    while i < len(source):
        token = source[i : i + 2] if source[i] == "\\" else source[i]
        i += len(token)
        if token == "\\b" and java:
            following = source[i : i + 2]
            if pattern.open_edges:
                out.append(_WORD_EDGE)
            elif following[:1].isalnum() or following[:1] in ("(", "[") or following == "\\d":
                out.append(_WORD_START)
            else:
                out.append(_WORD_END)
        elif token == "\\s":
            out.append(_SPACE if in_class else f"[{_SPACE}]")
        elif token == "\\S":
            out.append(f"[^{_SPACE}]")
        elif token == "." and not in_class:
            out.append(_NOT_NEWLINE)
        else:
            if token == "[":
                in_class = True
            elif token == "]":
                in_class = False
            out.append(token)
    return ("(?i)" if pattern.ignore_case else "") + "".join(out)


# ---------------------------------------------------------------------------
# Names, patterns, weights and their order decide the results.
# ---------------------------------------------------------------------------
PII = (
    Pattern("US_SOCIAL_SECURITY_NUMBER", r"\b\d{3}-\d{2}-\d{4}\b"),
    Pattern(
        "EMAIL",
        r"[\w.+-]+@[\w-]+\.[\w.-]+",
        # Only start where a run of local-part characters starts (or where the
        # last match ended), and never give characters back: linear, same hits.
        java_source=r"(?:\G|(?<![\w.+-]))[\w.+-]++@[\w-]++\.[\w.-]+",
    ),
    Pattern(
        "PHONE",
        r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
        open_edges=True,
        # Test the first character before the two-sided word edge.
        java_source=r"(?=[+(\d])\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    ),
    Pattern(
        "NAME",
        r"\b[A-Z][a-z]+ [A-Z][a-z]+\b",
        # Look behind only where a capital was found.
        java_source=r"[A-Z](?<!\w[A-Z])[a-z]+ [A-Z][a-z]+\b",
    ),
)

SECRETS = (
    Pattern("AWS_ACCESS_KEY", r"\bAKIA[0-9A-Z]{16}\b"),
    Pattern(
        "AWS_SECRET_KEY",
        r"\b(?:aws_secret_access_key|secret)\b\s*[:=]\s*[A-Za-z0-9/+]{40}\b",
        ignore_case=True,
        open_edges=True,
    ),
    Pattern("PASSWORD", r"\bpassword\s*[:=]\s*\S+", ignore_case=True),
    Pattern(
        "PIN",
        r"\bpin\s*[:=]\s*\d{4,}\b",
        ignore_case=True,
        java_source=r"pin(?<!\wpin)\s*[:=]\s*\d{4,}\b",
    ),
)

MISCONDUCT = Pattern(
    "MISCONDUCT",
    r"\b(pick(?:ing)?\s+(?:a\s+|someone'?s\s+)?pocket|pickpocket|shoplift|hot[\s-]?wire"
    r"|pick\s+a\s+lock|break\s+in(?:to)?\s+(?:a\s+)?(?:house|car|home)"
    r"|launder(?:ing)?\s+money|counterfeit|evade\s+(?:taxes|the\s+police))\b",
    ignore_case=True,
)

INJECTION = (
    Pattern(
        "instruction_override",
        r"\bignore\s+(?:all\s+|the\s+)?(?:previous|prior|above)\s+instructions?\b",
        ignore_case=True,
        weight=0.85,
    ),
    Pattern(
        "instruction_override",
        r"\b(?:disregard|forget)\s+(?:everything|all|your)\b",
        ignore_case=True,
        weight=0.8,
    ),
    Pattern(
        "system_prompt_extraction",
        r"\b(?:reveal|show|print|repeat|expose)\b.{0,30}\b(?:system\s+)?prompt\b",
        ignore_case=True,
        weight=0.6,
    ),
    Pattern(
        "role_play_bypass",
        r"\b(?:you are now|act as|pretend (?:to be|you))\b",
        ignore_case=True,
        weight=0.7,
    ),
    Pattern(
        "jailbreak",
        r"\bDAN\b|\bdeveloper mode\b",
        ignore_case=True,
        weight=0.9,
        # Look behind only where the words were found.
        java_source=r"DAN(?<!\wDAN)\b|developer mode(?<!\wdeveloper mode)\b",
    ),
)

TOPICS = (
    Pattern(
        "medical_diagnosis",
        r"\b(?:ibuprofen|dosage|dose|\d+\s?mg\b|diagnos|symptom|medication|prescri)",
        ignore_case=True,
    ),
    Pattern(
        "legal_advice",
        r"\b(?:lawsuit|legal advice|sue|liable|liability|contract law)\b",
        ignore_case=True,
    ),
)

TAG_CHARS = r"[\x{E0000}-\x{E007F}]"
BIDI_CONTROL = r"[\x{202A}-\x{202E}\x{2066}-\x{2069}\x{061C}\x{200E}\x{200F}]"
ZERO_WIDTH = r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{00AD}\x{180E}]"

# Look-alike letters (code point) and the ASCII letter each one imitates.
HOMOGLYPHS = {
    # Cyrillic, lower case
    0x0430: "a", 0x0435: "e", 0x043E: "o", 0x0440: "p", 0x0441: "c", 0x0443: "y",
    0x0445: "x", 0x0455: "s", 0x0456: "i", 0x0458: "j", 0x043A: "k", 0x043C: "m",
    # Cyrillic, upper case
    0x0410: "A", 0x0412: "B", 0x0415: "E", 0x041A: "K", 0x041C: "M", 0x041D: "H",
    0x041E: "O", 0x0420: "P", 0x0421: "C", 0x0422: "T", 0x0425: "X", 0x0423: "Y",
    # Greek
    0x03BF: "o", 0x039F: "O", 0x0391: "A", 0x0392: "B", 0x0395: "E", 0x0397: "H",
    0x0399: "I", 0x039A: "K", 0x039C: "M", 0x039D: "N", 0x03A1: "P", 0x03A4: "T",
    0x03A5: "Y", 0x03A7: "X", 0x0396: "Z",
}
CONTROL_CHARS = r"[\x{00}-\x{08}]"
# ---------------------------------------------------------------------------

HIDDEN_CHARS = "[" + "".join(c[1:-1] for c in (TAG_CHARS, BIDI_CONTROL, ZERO_WIDTH)) + "]"
HOMOGLYPH_FROM = "".join(map(chr, HOMOGLYPHS))
HOMOGLYPH_TO = "".join(HOMOGLYPHS.values())
HOMOGLYPH_CLASS = "[" + "".join(rf"\x{{{cp:04X}}}" for cp in HOMOGLYPHS) + "]"
# One range around all look-alikes: cheaper to test than the class itself.
HOMOGLYPH_RANGE = rf"[\x{{{min(HOMOGLYPHS):04X}}}-\x{{{max(HOMOGLYPHS):04X}}}]"
# Every character that stripping, NFKC or the look-alike map can act on.  Outside it
# lie ASCII and the accented Latin letters U+00C0..U+012F, which all three keep.
MAY_CHANGE = r"[\x{80}-\x{BF}\x{0130}-\x{10FFFF}]"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
