"""Fixed values of the notebook's grammar."""

# Known code prefixes and how often each was observed.
PREFIX_COUNTS = {
    "LA": 3, "PSA": 23, "SAA": 4, "SAG": 2, "SAH": 3, "SAJ": 1, "SAL": 5, "SAP": 8, "SAS": 4, "SAT": 2, "SAU": 1,
    "SAY": 3, "SC": 1, "SCA": 8, "SCC": 8, "SCE": 6, "SCF": 9, "SCG": 6, "SCH": 1, "SCI": 3, "SCJ": 10, "SCL": 19,
    "SCO": 70, "SCP": 34, "SCS": 5, "SCT": 23, "SCU": 6, "SE": 1, "SEA": 20, "SEC": 1, "SEE": 29, "SEF": 4, "SEG": 43,
    "SEJ": 1, "SEL": 26, "SEO": 12, "SEP": 6, "SES": 16, "SET": 21, "SEU": 15, "SEY": 5, "SFA": 16, "SFC": 43, "SFE": 46,
    "SFF": 32, "SFG": 14, "SFH": 11, "SFI": 10, "SFJ": 9, "SFL": 50, "SFO": 19, "SFP": 19, "SFS": 14, "SFT": 13, "SFU": 9,
    "SFY": 40, "SGA": 18, "SGC": 16, "SP": 1, "SX": 1, "SY": 1, "TS": 3, "TT": 4, "TY": 2, "TZ": 3,
}

# Letters that a digit glyph may stand for, most likely first.
DIGIT_AS_LETTERS = {
    "0": ["O", "D", "Q", "U"], "1": ["I", "L", "T", "J"], "2": ["Z", "R"], "3": ["B", "E"], "4": ["A", "Y", "U"],
    "5": ["S"], "6": ["G", "C", "L"], "7": ["T", "I", "F", "J", "Y"], "8": ["B", "S"], "9": ["G", "P", "J", "Y", "A"],
}

# Digits that a letter glyph may stand for, most likely first.
LETTER_AS_DIGITS = {
    "O": ["0"], "D": ["0"], "Q": ["0"], "U": ["0", "4"], "I": ["1"], "L": ["1"], "T": ["7", "1"], "J": ["1", "7"],
    "Z": ["2"], "R": ["2"], "B": ["8", "3"], "E": ["3"], "A": ["4", "9"], "V": ["4"], "Y": ["4", "7", "9"], "S": ["5"],
    "G": ["6", "9"], "C": ["6", "0"], "F": ["7"], "P": ["9"],
}

# Letters that a letter glyph may stand for besides itself, most likely first.
LETTER_AS_LETTERS = {
    "T": ["I", "J", "F", "Y"], "I": ["T", "J", "L"], "J": ["T", "I", "Y"], "E": ["F", "C", "L"], "F": ["E", "P", "T"],
    "C": ["G", "O", "E", "L"], "G": ["C", "O", "Q", "S"], "O": ["D", "Q", "C", "U"], "D": ["O", "P", "B"],
    "U": ["V", "O", "N", "W"], "V": ["U", "Y"], "S": ["G", "Z"], "A": ["H", "R", "U"], "P": ["F", "R", "D"],
    "L": ["I", "C", "E"], "Y": ["T", "V", "J"], "H": ["A", "N", "K"], "M": ["N", "W"], "N": ["M", "H", "U"],
    "B": ["R", "D", "P"], "R": ["P", "B", "K"], "K": ["R", "H"], "X": ["K", "Y"], "W": ["M", "V"], "Q": ["O", "G"],
    "Z": ["S", "Q"],
}

# Fixed values: (letters, digits) of a code, most likely first; edits allowed; width of the search; candidates kept.
LAYOUTS = ((3, 5), (2, 5), (3, 6), (2, 6))
MAX_EDITS, WIDTH, KEPT = 2, 24, 5

# Placeholders in declared order, with the spellings that mean them; largest edit distance.
PLACEHOLDERS = (
    ("NoMeter", ("no meter", "nometer", "no metar", "no mtr", "meter not found")),
    ("MeterMissing", ("meter missing", "missing meter", "metermissing")),
    ("EmptyPlot", ("empty plot", "emptyplot", "vacant plot")),
    ("Empty", ("empty",)),
    ("Plot", ("plot",)),
)
TOKEN_DISTANCE = 2

# Lines that are marks of a section and no records (matched from the start, case ignored).
SECTION_MARKERS = (
    "^end\\s+block\\s*[\"'`]?[a-z][\"'`]?\\.?$",
    "^[\\s\\-_=~—–]*([x*×][\\s\\-_=~—–]*){2,}$",
    "^[\\s\\-_=~—–]{4,}$",
    "^servey\\s*#?$",
    "^survey\\s*#?$",
    "^meter\\s*#?$",
    "^remarks?$",
    "^p(age)?\\.?\\s*\\d{1,3}$",
)

# Glyphs read as a "same as above" mark; pointer glyphs; marks of a side code.
DITTO_GLYPHS = "\"'’“”„″«»×x*%~,·•"
POINTER_GLYPHS = "←→=>➜⟶"
CODE_MARKS = "+#†"

# Code-point ranges of the script that is dropped from remarks.
NON_LATIN = "[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]"

# Statuses; those that need no review.
STATUSES = (
    "ok", "corrected", "low_confidence", "disagreement", "invalid_prefix", "invalid_format", "ambiguous", "manual_review", "empty", "skipped",
)
SETTLED = ("ok", "corrected", "empty", "skipped")
SURVEY_PREFIX = "KE-"
CODE_SIGN = "-"
REMARK_JOINER = ", "
