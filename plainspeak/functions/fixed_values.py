"""Fixed values.

Everything in this file is data that has to be exactly this for results to be
right: text patterns, character sets, label names, formats, sizes. No logic.
"""

# --- Fixed values: text patterns, applied in this order -----------------------
MENTION = r"(@\w{1,15})"
HASHTAG = r"#(\w{1,})"
URL = (
    r"((https?|ftp|file):\/{2,3})+([-\w+&@#/%=~|$?!:,.]*)"
    r"|(www.)+([-\w+&@#/%=~|$?!:,.]*)"
)
EMAIL = r"[\w.-]+@[\w.-]+\.[a-zA-Z]{1,}"

# --- Fixed values: emoji code point ranges ------------------------------------
EMOJI_RANGES = (
    (0x1F600, 0x1F64F),  # emoticons
    (0x1F300, 0x1F5FF),  # symbols and pictographs
    (0x1F680, 0x1F6FF),  # transport and map symbols
    (0x1F1E0, 0x1F1FF),  # flags
)
# Only used with extended=True: supplemental pictographs, heart, joiner, selector.
EMOJI_EXTENDED_RANGES = (
    (0x1F900, 0x1F9FF),
    (0x1FA70, 0x1FAFF),
    (0x2600, 0x27BF),
    (0x200D, 0x200D),
    (0xFE0F, 0xFE0F),
)

# --- Fixed values: characters that separate vocabulary words ------------------
VOCABULARY_SEPARATORS = '!"#$%&()*+,-./:;<=>?@[\\]^`{|}~\t\n'

# --- Fixed values: Unicode white space, in a notation Java and RE2 both read --
WHITESPACE_CLASS = (
    r"\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

# The same characters one by one.
WHITESPACE_CHARACTERS = (
    "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- Fixed values: labels ------------------------------------------------------
LABEL_NAMES = {0: "Clean", 1: "Offensive", 2: "Hate"}
LABEL_CAPITALS = {0: "CLEAN", 1: "OFFENSIVE", 2: "HATE"}
STATUS_COLOURS = {"Clean": "green", "Offensive": "orange", "Hate": "red"}

# --- Fixed values: time formats (Spark pattern letters) ------------------------
MINUTE_FORMAT = "HH:mm dd-MM-yyyy"
CLOCK_FORMAT = "HH:mm:ss"
DATE_FORMAT = "dd-MM-yyyy"

# --- Fixed values: sizes --------------------------------------------------------
SEQUENCE_LENGTH = 100
VECTOR_VOCABULARY_LIMIT = 10000
VECTOR_DIMENSION = 300
RECENT_ROWS = 10
TOP_WORDS = 20

# --- Fixed values: page addresses ------------------------------------------------
RESERVED_PAGE_ID = "profile.php"
