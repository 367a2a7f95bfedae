"""Regular expressions and the English stop-word list.

Word boundaries around numbers and dates are spelled out as ASCII look-arounds, because ``\\b``
changed meaning between Java versions.
"""

from __future__ import annotations

# Word tokenizer: URL, e-mail, number, word with inner apostrophes or hyphens, any other character.
# Runs before an "@" are possessive, which changes no match and spares the backtracking.
TOKEN = (
    r"(?:https?://[^\s]+)"
    r"|(?:[\p{L}\p{N}._%+-]++@[\p{L}\p{N}.-]+\.\p{L}+)"
    r"|(?:\p{N}+(?:[.,]\p{N}+)*)"
    r"|(?:\p{L}+(?:['’-]\p{L}+)*)"
    r"|[^\s\p{L}\p{N}]"
)
# The same for texts without "@" and "://", which have neither addresses; their words are read once, not twice.
PLAIN_TOKEN = r"(?:\p{L}+(?:['’-]\p{L}+)*)|[^\s\p{L}\p{N}]|(?:\p{N}+(?:[.,]\p{N}+)*)"
NUMERIC_TOKEN = r"^\p{N}+$"
ALNUM_TOKEN = r"^[\p{L}\p{N}]+$"

LINE_BREAKS = r"[\r\n]+"
URL = r"""(?:https?://|www\.)[^\s<>"]+"""
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
)
DATE = (
    r"(?<![A-Za-z0-9_])"
    r"(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{1,2} (?:" + MONTHS + r") \d{4})"
    r"(?![A-Za-z0-9_])"
)
NUMBER = r"(?<![A-Za-z0-9_])\d+(?:[.,]\d+)*(?![A-Za-z0-9_])"
DIGITS = r"\d+"
SPACES = r" {2,}"
# Texts without a match have nothing that the masks could replace.
MASKABLE = r"[0-9@]|https?://|www\."

# Whitespace as Unicode defines it, spelled out so that it does not depend on regex flags.
UNICODE_SPACE = (
    r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# Pre-tokenizer of byte-level BPE: contractions, words, numbers, punctuation runs, whitespace.
BPE_WORD = (
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{UNICODE_SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{UNICODE_SPACE}]+(?![^{UNICODE_SPACE}])|[{UNICODE_SPACE}]+"
)

STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
    her hers herself it its itself they them their theirs themselves what which who whom this that
    these those am is are was were be been being have has had having do does did doing a an the and
    but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here
    there when where why how all any both each few more most other some such no nor not only own
    same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll
    i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
    they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't
    shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
    what's when's where's who's why's would
    """.split()
)
