"""Regular expressions shared by the text functions, in Java's syntax.

Java's `\\w` is ASCII only, so word characters are spelled out. Classes are built from few
named sets: Java compiles a class of three or more ranges into nested calls that run several
times slower. `\\p{Alnum}` is ASCII here.
"""

WORD = r"\p{L}\p{N}_"
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"

# The clean-up patterns, in the order they apply.
WROTE = rf"[{WORD}]+wrote"
GAGT = rf"gagt[{WORD}]*"
PHONE_MODEL = r"[a-zA-Z][0-9]+[a-zA-Z]*"
MENTION = rf"[@][{WORD}]+"
URL = (r"(?:(?:https?|ftp)://|www\.)[A-Z\-a-z0-9+&@#/%?=~_|!:,.;]*"
       r"[A-Z\-a-z0-9+&@#/%=~_|]")
DIGITS = r"[0-9]+"
AM_PM = rf"(^|[^{WORD}])[0-9]*[apAP][mM](?=[^{WORD}]|$)"
NON_WORD = rf"[^{WORD}]+"
NON_ASCII = r"[^\x00-\x7F]"

SPACES = rf"[{SPACE}]+"
SENTENCE_END = rf"([.!?]+)[{SPACE}]+"
ASCII_SPACES = r"[\s\x1c-\x1f]+"
SENTENCE_MARK = "\u0001"
ASKING = "wh(?:o|at|en|ere|y)|how"
WORD_OR_MARK = rf"[{WORD}]+|[^{WORD}{SPACE}]"
VECTOR_TOKEN = rf"[{WORD}][{WORD}]+"

# Characters blanked before question words are counted (hyphen not among them).
QUESTION_BLANKS = r"[\d!@#$%^&*+=()\[\]?<>/\\^_.,;:\"']"
ENTITIES = (rf"(@\p{{Alnum}}+)|(#\p{{Alnum}}+)|([^\p{{Alnum}} \t])|"
            rf"([{WORD}]+://[^{SPACE}]+)")
TAGS = r"[@#]\p{Alnum}+"
TAGS_AND_MARKS = r"[@#]\p{Alnum}+|[^\p{Alnum} \t]"  # what is left of ENTITIES without ://
MARKS = r"[^\p{Alnum} \t]"  # and without @ and # as well
